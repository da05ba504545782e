"""daftar: a Spark-native engine for analysing registers of orders.

Everything is a function from DataFrames to DataFrames.  Nothing here runs at
import time, and no function keeps state between calls.
"""
