"""parlance: conversation-corpus analytics as Spark DataFrame operators.

Every public function maps DataFrames to DataFrames and triggers no action
unless its docstring says so. Tables are keyed by ``conv_id``.
"""

__version__ = "0.1.0"
