"""Workload analytics on PySpark: jobs, workflows, schedules, dead letters, events, workers."""
