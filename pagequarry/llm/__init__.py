"""Training-data operators over `documents`; nothing else in the library imports this subpackage."""
