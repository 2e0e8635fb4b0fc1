"""Single-document logic that runs inside a task: plain Python over plain values, no Spark."""
