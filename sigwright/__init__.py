"""sigwright: sig-mer (unique k-mer) analytics expressed as Spark DataFrame plans."""
