"""Analytics of agent execution traces and their cost ledgers on Spark."""
