"""Alert-triage analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames; nothing here collects
rows to the driver.  ``operators`` holds the building blocks, ``plans`` composes
them into batch jobs and ``streaming`` runs the same blocks on micro-batches.
"""
