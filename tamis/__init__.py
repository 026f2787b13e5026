"""tamis: a Spark-native data-quality and remediation engine.

Subpackages: ``functions`` (Column expressions), ``operators`` (DataFrame ->
DataFrame operators: sampling, profile, validate, corrupt, repair, drift,
evaluate, features, models), ``sources`` (tables and files), ``streaming``
(Structured Streaming monitor) and ``plans`` (the registered queries with
their SQL twins).
"""

__version__ = "0.1.0"
