"""tidegauge: drift, reliability and routing analytics over time-ordered Spark tables."""
