"""twinlens: paired-model evaluation analytics and data quality operators on Spark."""
