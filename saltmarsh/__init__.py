"""saltmarsh: a Spark-first analytics engine for evidence-backed knowledge graphs."""
