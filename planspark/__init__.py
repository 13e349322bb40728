"""PlanSpark: analytics on floor-plan drawings and their annotation data, written for PySpark.

Every operator takes and returns DataFrames keyed by drawing (``dwg_id``) or
image, so a corpus of drawings is one Spark job.
"""
