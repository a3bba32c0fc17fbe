"""tillroll: analytic operators for retail transaction lines, written for Spark.

Every operator takes a sales-line DataFrame (see ``tillroll.sources.schema``) and returns a lazy DataFrame.
"""
