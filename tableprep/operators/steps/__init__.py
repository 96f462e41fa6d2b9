"""The closed list of preprocessing operations."""

from tableprep.operators.steps.categories import FrequencyEncoding, OneHotEncoding, OrdinalEncoding, RareCategoryGrouping
from tableprep.operators.steps.columns import DropColumns, RenameColumns, ReorderColumns
from tableprep.operators.steps.duplicates import RemoveDuplicateRows
from tableprep.operators.steps.features import DatetimeExtract, TextBasicFeatures
from tableprep.operators.steps.missing import (
    AddMissingIndicator, CategoricalImputation, NumericImputation, ReplacePlaceholderValues,
)
from tableprep.operators.steps.numbers import LogTransform, NumericScaling, OutlierClipping

OPERATIONS = {
    op.name: op
    for op in (
        DropColumns(), RemoveDuplicateRows(), ReplacePlaceholderValues(), NumericImputation(),
        CategoricalImputation(), AddMissingIndicator(), RareCategoryGrouping(), OneHotEncoding(), OrdinalEncoding(),
        FrequencyEncoding(), NumericScaling(), OutlierClipping(), LogTransform(), DatetimeExtract(),
        TextBasicFeatures(), RenameColumns(), ReorderColumns(),
    )
}
