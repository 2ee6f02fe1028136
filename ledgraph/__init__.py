"""Evidence-backed knowledge graphs as DataFrame dataflows on Spark."""
