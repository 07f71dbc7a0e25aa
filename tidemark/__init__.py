"""tidemark: personal-baseline analytics on Spark.

DataFrame in, DataFrame out: folds, rolling baselines, facts and rules, explanation, alerts, interval joins, metrics.
"""
