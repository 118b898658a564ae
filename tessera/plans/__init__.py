"""Plan building blocks: parameters, scratch tables, pipelines of operators."""
