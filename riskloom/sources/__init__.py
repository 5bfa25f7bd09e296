"""Reading, checking and writing tables; saving and loading trained models."""
