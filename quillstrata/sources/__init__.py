"""Readers, writers and durable intermediate tables."""

from quillstrata.sources.tables import Scratch, bound_batches, durable, durable_table, read_table, scratch_dir, shared, spread, work_folder

__all__ = ["Scratch", "bound_batches", "durable", "durable_table", "read_table", "scratch_dir", "shared", "spread", "work_folder"]
