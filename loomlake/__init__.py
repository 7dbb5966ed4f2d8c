"""loomlake: event-log, fact-pipeline and scoring queries as Spark plans."""
