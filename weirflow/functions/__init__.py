"""The scalar expression language: text to typed Spark columns."""

from weirflow.functions.compiler import Diagnostic, compile_expression, register_function, validate

__all__ = ["Diagnostic", "compile_expression", "register_function", "validate"]
