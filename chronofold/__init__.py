"""chronofold: append-only event logs, folded views and versioned key/value reads on Spark."""
