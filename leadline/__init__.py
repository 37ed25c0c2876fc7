"""leadline: delivery-promise, sales and demand analytics on Spark DataFrames."""
