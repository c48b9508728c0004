"""logwarden: user-behaviour and token-threat analytics over access logs, as Spark DataFrame operators."""

from logwarden.config import Config

__all__ = ["Config"]
