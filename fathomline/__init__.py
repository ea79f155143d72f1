"""Panel frontier analytics and training-data operators on Spark."""
