"""Place cleaning, matching and reporting jobs for PySpark.

Every operator takes and returns DataFrames (or builds a Column used inside such
a job); nothing here collects rows to the driver.
"""
