"""Training-data operators.  Nothing outside this folder imports it; deleting it leaves the engine whole."""
