"""Resale price valuation on Spark: sales extract, features, imputation, quantile forest, scoring."""
