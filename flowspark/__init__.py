"""flowspark: flow-style event analytics written against the Spark DataFrame API."""
