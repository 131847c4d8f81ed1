"""Prediction-market analytics as Spark DataFrame operators."""
