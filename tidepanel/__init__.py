"""Panel analytics for market research data, written as Spark DataFrame operators."""
