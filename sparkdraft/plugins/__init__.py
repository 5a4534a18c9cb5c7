"""User plug-ins: scorers (U01), tokenizers (U02), batch generation
and custom collators (U04). Built-in behaviour stays in native Spark
expressions; only user-supplied Python code runs in Python workers, always
Arrow-batched."""
