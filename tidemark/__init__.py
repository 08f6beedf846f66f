"""tidemark: candle analytics and corpus preparation as Spark jobs."""
