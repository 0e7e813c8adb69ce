"""Card-game analytics as Spark DataFrame jobs.

Sub-packages
------------
functions   Column expressions (no jobs, no shuffles)
sources     scans and sinks
operators   DataFrame -> DataFrame operators
plans       whole flows built from the operators
streaming   the same flows on Structured Streaming
"""
