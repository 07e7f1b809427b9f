"""Waybill: delivery-contract analytics on Spark. Contracts and observations are DataFrames, gates are queries."""
