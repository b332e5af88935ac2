"""Intermediate tables in the folder that the driver and all executors share."""

from veridelta.shared import Tables, folder

__all__ = ["Tables", "folder"]
