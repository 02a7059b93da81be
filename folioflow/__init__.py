"""A PySpark engine for page-oriented documents."""

from importlib import import_module

_WHERE = {"Engine": "engine", "Result": "engine", "ConfigurationError": "options", "ExecutionError": "options", "Options": "options", "RunError": "options"}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    """Names of the package are loaded when they are first used, as Python workers need few of them."""
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(import_module(f".{_WHERE[name]}", __name__), name)
