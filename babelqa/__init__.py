"""babelqa: the data side of multilingual question answering, as Spark jobs.

Subpackages:
  functions  - Column -> Column expressions (text, locale, prompts, arrays, params)
  operators  - DataFrame -> DataFrame operators (sampling, batching, repetition,
               vocabulary, scoring, metrics, inference, lookups, records)
  sources    - readers, writers and the fixture views over the driver tables
  plans      - end-to-end compositions and the query registry with its SQL oracle
  streaming  - Structured Streaming versions of incremental scoring and log windows
"""

__version__ = "0.1.0"
