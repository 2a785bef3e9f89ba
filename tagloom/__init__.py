"""Label evaluation, rule labelling, near-duplicate removal and labelling workflow on Spark."""
