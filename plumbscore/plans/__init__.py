"""Jobs made of operators: training, and monitored deployment."""
