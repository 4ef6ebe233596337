"""Flowboard: order-flow benchmark analytics as PySpark DataFrame operators."""
