"""quarry: data-mining operators as Spark DataFrame transformations."""
