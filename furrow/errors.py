"""Errors that callers may want to tell apart."""


class FurrowError(Exception):
    """Base of all errors of this library."""


class UnsupportedDatabase(FurrowError):
    pass


class IntrospectionError(FurrowError):
    pass


class ConfigError(FurrowError):
    pass


class CircularDependency(FurrowError):
    pass


class UnbreakableCycle(FurrowError):
    pass


class ForeignKeyResolution(FurrowError):
    pass


class UniqueExhausted(FurrowError):
    pass


class CompositeUniqueExhausted(FurrowError):
    pass


class UnsupportedStrategy(FurrowError):
    pass


class LockFileError(FurrowError):
    pass


class ProfileError(FurrowError):
    pass


class AIResponseError(FurrowError):
    pass


class CheckConstraintViolation(FurrowError):
    pass


class SchemaDrift(FurrowError):
    pass
