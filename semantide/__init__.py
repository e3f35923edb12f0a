"""Program-semantics analytics as Spark plans.

Sub-packages: ``sources`` (readers and sinks), ``functions`` (column
expressions), ``operators`` (DataFrame to DataFrame), ``plans`` (queries over
the project's tables and their SQL), ``streaming`` (continuous scoring) and,
optionally, ``llm`` (training-data operators; nothing here imports it).
"""
