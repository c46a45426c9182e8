"""Spark-native constrained stratified sampling, spatial joins and dataset QA."""
