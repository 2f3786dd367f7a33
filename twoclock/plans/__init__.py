from .spec import (Aggregate, Convert, EntitySpec, Expression, GroupedSpec, IDENTITY, Model,
                   Parameter, Slot, SpecError, Unfilled)

__all__ = ["Aggregate", "Convert", "EntitySpec", "Expression", "GroupedSpec", "IDENTITY",
           "Model", "Parameter", "Slot", "SpecError", "Unfilled"]
