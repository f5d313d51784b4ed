"""Monitoring of model-activation telemetry, written as PySpark DataFrame jobs.

Importing the package never starts a session; every function takes DataFrames
(or a session, for readers) and returns DataFrames.
"""

__version__ = "0.1.0"
