"""What the operators of this subpackage share with the catalog."""

from mediacat.storage import components, partitions, row_numbers, shared_dir, stored, table

__all__ = ["components", "partitions", "row_numbers", "shared_dir", "stored", "table"]
