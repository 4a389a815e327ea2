"""codelode: code search, symbol graphs and text retrieval as Spark DataFrame plans."""
