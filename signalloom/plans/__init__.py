"""Multi-step jobs: model-ready data, classifiers, and transfer experiments."""
