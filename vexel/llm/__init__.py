"""Training-data operators: ten DataFrame jobs and the pipeline over them."""
