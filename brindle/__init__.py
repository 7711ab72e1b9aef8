"""brindle: web-corpus analytics written against the DataFrame API of Apache Spark.

operators/   row, rule, graph and report operators over page corpora
sources/     readers and the HTML shredder
functions/   column-level text, URL and number functions
plans/       named queries put together from operators, with their SQL
llm/         operators for training-data pipelines (nothing else imports it)
"""
