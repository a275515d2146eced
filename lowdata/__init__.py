"""lowdata: Spark-native holdout, scarcity, augmentation and evaluation operators.

Sub-packages:
  functions  - column expressions (seeded hashing, coercions, metric formulas)
  sources    - readers/writers and fixture bindings of the driver tables
  operators  - DataFrame -> DataFrame operators (splits, sampling, augment, kNN,
               model, metrics, thresholds, pairing, reports)
  plans      - composed jobs (run grid, evaluation of many runs, registered queries)
  streaming  - rolling-window evaluation over a prediction stream
"""

__version__ = "0.1.0"
