"""millrace: governed analytics and data preparation on Spark."""
