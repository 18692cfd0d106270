"""The engine for documents of any shape: functions of one document, run in Arrow batches."""
