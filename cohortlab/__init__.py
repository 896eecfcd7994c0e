"""Cohort and content analytics as Spark jobs.

Sub-packages: ``sources`` (scans and sinks), ``functions`` (Column
expressions), ``operators`` (DataFrame transformations), ``streaming``
(stateful jobs) and ``plans`` (whole jobs and the query catalogue).
"""

__version__ = "0.1.0"
