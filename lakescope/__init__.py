"""Health, cost, privacy and migration audits of Apache Iceberg tables as Spark dataflows."""
