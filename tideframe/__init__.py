"""Tideframe: continuous and replayed event-stream queries on PySpark DataFrames."""
