"""Graph, text and event analytics as DataFrame-in, DataFrame-out operators on Spark."""
