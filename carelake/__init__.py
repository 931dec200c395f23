"""carelake: Spark-native supply-chain analytics.

Curated facts and dimensions, KPI aggregates, demand forecast and replenishment,
insight queries, price marts, a SQL cookbook and incremental sales aggregates, all
expressed as lazy DataFrame / Spark SQL operators without Python UDFs.
"""

__version__ = "0.1.0"
