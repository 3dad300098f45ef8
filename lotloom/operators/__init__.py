"""Operators over trading lists: functions from DataFrames to DataFrames."""
