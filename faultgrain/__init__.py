"""Error-event analytics on Spark DataFrames.

``functions`` builds columns (fingerprints, normalisation, times), ``sources``
decodes, reads and writes events, ``operators`` answers queries and keeps
issues, alerts, quotas and access, ``streaming`` runs the same operators on
streams, ``plans`` holds the registered queries.
"""
