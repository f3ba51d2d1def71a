"""Holdfast: customer retention analytics on Spark.

``functions``  column expressions (rules, health score, text formats)
``operators``  DataFrame in, DataFrame out (features, reports, checks)
``sources``    readers and writers (CSV, customer table, result tables)
``plans``      model training and the end-to-end scoring runs
``queries``    the registered queries and their SQL counterparts
"""
