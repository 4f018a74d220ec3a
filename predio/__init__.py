"""predio: cleaning, description and price modelling of property listings on Spark."""
