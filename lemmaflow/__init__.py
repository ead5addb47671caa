"""lemmaflow: Datalog-style rules, bit vectors, mergeable statistics and Z-order keys as Spark DataFrame plans."""
