"""Readers and writers: text layouts, images, point clouds, archives, and adapters of plain tables."""
