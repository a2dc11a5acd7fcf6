"""Workflow analytics and typed dataflow on Spark, plus corpus preparation operators."""
