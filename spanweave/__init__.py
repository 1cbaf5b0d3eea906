"""Entity linking in short texts, and text operators, as Spark DataFrame plans."""
