"""Plan helpers shared by all operators: cutting lineage and sizing partitions."""
