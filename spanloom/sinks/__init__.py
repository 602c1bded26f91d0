"""Writers for call graphs."""
