"""Pure numpy functions of one sequence; nothing here imports Spark."""
