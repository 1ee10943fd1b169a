"""Sources and sinks."""

from . import loaders as loaders  # registers the built-in datasets
