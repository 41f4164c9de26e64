"""Profile operators: functions from DataFrames to DataFrames."""
