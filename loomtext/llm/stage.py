"""Session helpers of the operators, from the library's shared plans."""

from loomtext.plans.shared import Scratch, bounded, cleared_after, drop_folder, free_name, new_folder, shared_dir, small_batches, tables

__all__ = ["Scratch", "bounded", "cleared_after", "drop_folder", "free_name", "new_folder", "shared_dir", "small_batches", "tables"]
