"""Compositions: the whole cohort workflow, table bindings and the query catalogue."""
