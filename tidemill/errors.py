"""What goes wrong, by whose fault."""


class TideError(Exception):
    """Base of all errors that the engine raises on purpose."""


class ConfigError(TideError):
    """The pipeline is set up wrongly."""


class DeclarationError(TideError):
    """A stage, dataset or selector is declared wrongly."""


class StateError(TideError):
    """The stored data isn't as the declaration needs it."""
