"""Regional unit-cost analytics as Spark DataFrame operators.

Sub-packages
------------
functions   Column builders: money, text, codes, exact medians, positions.
sources     Table views, staging scans, columnar and document sinks, manifests.
operators   DataFrame -> DataFrame operators, one module per family.
plans       The registry that binds each operator to the driver tables.
"""
