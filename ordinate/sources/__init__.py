"""Where sequences come from."""

from ordinate.sources.factories import create_tree_from_flat, empty, from_iterable, from_range, from_table, generate, recursive_generator, repeat

__all__ = ["create_tree_from_flat", "empty", "from_iterable", "from_range", "from_table", "generate", "recursive_generator", "repeat"]
