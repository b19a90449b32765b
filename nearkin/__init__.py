"""nearkin: item similarity and training-data preparation on Spark."""
