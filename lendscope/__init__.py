"""lendscope: Spark-native risk analytics for binary-outcome applicant tables.

Cleaning, profiling, feature building, exact stratified splitting,
distributed oversampling, MLlib model comparison and tuning, threshold and
metric tables, and one scoring path shared by batch and streaming input.
Every operator is a DataFrame -> DataFrame function or an ML pipeline stage.
"""

__version__ = "0.1.0"
