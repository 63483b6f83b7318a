"""Spark-native document retrieval, entity graphs and conversation analytics.

Sub-packages
------------
``sources``    readers and writers (corpus folders, chat JSON, metric logs, parquet)
``functions``  column expressions (text, redaction, routing, vectors)
``operators``  DataFrame -> DataFrame operators
``plans``      end-to-end jobs built from operators, and the query registry
``streaming``  Structured Streaming jobs
"""
